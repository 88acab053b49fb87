"""Document toxicity by a subsequence string kernel with Nyström landmarks.

The kernel of two words (Lodhi et al., 2002) counts their common subsequences
of three characters, each occurrence weighted by DECAY to the power of the
characters it spans, over spans of at most SPAN; so a word with gaps, or with
characters put in, stays close to the word it hides.  Landmarks give each word
a short vector (Nyström), and a linear support vector machine separates the
vectors.  Labels are those of documents: every sentence of a clean document is
clean, and of a toxic document only the word that the machine finds worst is
taken as toxic, in turns (mi-SVM).  A document's score is that of its worst
word, made a probability on the documents learned from.

A run of three or more one-character words counts as one word (l o s e r).
Words longer than WIDTH characters are cut into windows that overlap by half.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from textflow.llm.labelled import judged, sample
from textflow.llm.stored import pick
from textflow.llm.words import RunHasher, texts

DECAY, SPAN, WIDTH = 0.6, 6, 20
#: Landmarks from toxic and from clean words, and of each more after some turns; documents of each class learned from; their bytes at most.
TOXIC_LANDMARKS, CLEAN_LANDMARKS, MORE_LANDMARKS, PER_CLASS, BYTES_EACH = 32, 8, 12, 1000, 1 << 15
#: A word that clean documents have too is taken as toxic if its share in toxic documents is CLEAR times that in clean ones, and LEAST toxic documents have it.
CLEAR, LEAST = 5.0, 5
#: Words whose margin a Python worker keeps.
KEPT = 1 << 18
SYMBOLS = 32


def symbol(codes: np.ndarray) -> np.ndarray:
    """Code points as one of SYMBOLS symbols: a-z by case-folding, other letters and signs by class."""
    out = np.where(codes < 128, 0, 27 + codes % 5).astype(np.int64)
    for low in (65, 97):
        letter = (codes >= low) & (codes < low + 26)
        out[letter] = codes[letter] - low + 1
    return out


def _rows(words: list[str]):
    """(indices, symbols) of the words of each length, 3 to WIDTH."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in range(3, WIDTH + 1):
        at = np.flatnonzero(size == n)
        if len(at):
            yield at, symbol(np.array([words[i] for i in at], f"U{n}").view(np.uint32).reshape(len(at), n))


def _triples(n: int):
    for i, j, k in combinations(range(n), 3):
        if k - i < SPAN:
            yield i, j, k, DECAY ** (k - i + 1)


def _ids(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of every subsequence of each row, weights)."""
    t = list(_triples(n))
    return np.stack([(s[:, i] * SYMBOLS + s[:, j]) * SYMBOLS + s[:, k] for i, j, k, _ in t], 1), np.array([w for *_, w in t], np.float32)


class Landmarks:
    """Kernel values of words with fixed words, both of length one in feature space."""

    def __init__(self, words: list[str]):
        self.words = words
        self.table = np.zeros((SYMBOLS ** 3, len(words)), np.float32)
        for at, s in _rows(words):
            ids, weight = _ids(s, s.shape[1])
            for row, w in zip(ids, at):
                np.add.at(self.table[:, w], row, weight)
        norm = np.sqrt((self.table ** 2).sum(axis=0))
        self.table /= np.where(norm > 0, norm, 1)

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for at, s in _rows(words):
            for low in range(0, len(at), 4096):
                some = slice(low, low + 4096)
                ids, weight = _ids(s[some], s.shape[1])
                total = np.zeros((len(ids), len(self.words)), np.float32)
                for k in range(ids.shape[1]):
                    total += weight[k] * self.table[ids[:, k]]
                # own length: equal subsequences of a word add up before they are squared
                order = np.argsort(ids, axis=1, kind="stable")
                run = np.take_along_axis(ids, order, 1)
                w = weight[order]
                new = np.ones(run.shape, bool)
                new[:, 1:] = run[:, 1:] != run[:, :-1]
                sums = np.add.reduceat(w.reshape(-1), np.flatnonzero(new.reshape(-1)))
                row = np.flatnonzero(new.reshape(-1)) // run.shape[1]
                norm = np.sqrt(np.bincount(row, sums ** 2, len(ids)))
                out[at[some]] = total / norm[:, None]
        return out


class Machine:
    """Linear SVM on Nyström vectors, and a document's probability."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        value, vector = np.linalg.eigh(landmarks.kernel(landmarks.words).astype(float))
        keep = value > 1e-4
        self.map = vector[:, keep] / np.sqrt(value[keep])
        self.weight, self.slope, self.shift = np.zeros(keep.sum() + 1), 1.0, 0.0

    def state(self) -> tuple:
        """What a machine consists of, in plain values."""
        return self.landmarks.words, self.map, self.weight, self.slope, self.shift

    @classmethod
    def of(cls, state: tuple) -> Machine:
        words, *rest = state
        machine = cls.__new__(cls)
        machine.landmarks = Landmarks(words)
        machine.map, machine.weight, machine.slope, machine.shift = rest
        return machine

    def vectors(self, words: list[str]) -> np.ndarray:
        z = self.landmarks.kernel(words) @ self.map
        return np.hstack([z, np.ones((len(z), 1))])

    def fit(self, z: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 2000.0, rounds: int = 30) -> None:
        """Squared hinge loss by Newton steps on the words within the margin; ``share``: weight of each word."""
        w = self.weight * 0
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-6
        for _ in range(rounds):
            inside = y * (z @ w) < 1
            a = z[inside] * (cost * share[inside, None])
            new = np.linalg.solve(ridge + a.T @ z[inside], a.T @ y[inside])
            if np.allclose(new, w, atol=1e-7):
                break
            w = new
        self.weight = w

    def margins(self, words: list[str]) -> np.ndarray:
        return self.vectors(words) @ self.weight

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps, with targets kept off 0 and 1."""
        n1, n0 = (y > 0).sum(), (y < 0).sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x, p = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
            step = np.linalg.solve((x * (s * (1 - s) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (s - target) + 1e-3 * p)
            p = p - np.clip(step, -2, 2)
        self.slope, self.shift = max(p[0], 1e-3), p[1]


_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def windows(word: str) -> list[str]:
    """A word without signs at its ends, in pieces the kernel takes."""
    word = _EDGES.sub("", word)
    if len(word) <= WIDTH:
        return [word]
    return [word[at:at + WIDTH] for at in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


class Units:
    """The distinct words of some texts: ``hash`` of each, ``at`` the words of
    the texts as indices into it, text by text from ``first``."""

    def __init__(self, values: list[bytes | None]):
        t = texts(values, lower=True)
        # a run of words of one code point, of one text, becomes one word; a code point has one byte that is not 10xxxxxx
        size = t.end - t.start
        single = np.append(size <= 4, False)
        short = np.flatnonzero(single)
        points = np.zeros(len(short), np.int64)
        for k in range(4):
            at = np.minimum(t.start[short] + k, len(t.buf) - 1)
            points += (k < size[short]) & ((t.buf[at] & 0xC0) != 0x80)
        single[short] = points == 1
        run = single[:-1] & np.append(False, single[:-2])
        run &= np.append(False, np.diff(t.owner()) == 0)
        lead = np.flatnonzero(~run)
        length = np.diff(np.append(lead, len(run)))
        start, end = t.start[lead], t.end[lead]
        joined = length >= 3
        end = np.where(joined, t.end[lead + length - 1], end)
        loose = np.flatnonzero(run & ~np.repeat(joined, length))  # of runs of two, the second word
        order = np.argsort(np.append(start, t.start[loose]), kind="stable")
        start, end = np.append(start, t.start[loose])[order], np.append(end, t.end[loose])[order]
        self.joined = np.append(joined, np.zeros(len(loose), bool))[order]
        self.first = np.searchsorted(start, t.begin)
        self.hash, self.one, self.at = np.unique(RunHasher(t.buf)(start, end), return_index=True, return_inverse=True)
        self._t, self._start, self._end = t.buf, start, end

    def text(self, i: int) -> str:
        k = self.one[i]
        word = self._t[self._start[k]:self._end[k]].tobytes()
        return (word.translate(None, b" \t\n\v\f\r") if self.joined[k] else word).decode()


def learn(rows: list[tuple[str, int]], seed: int = 11, turns: int = 6) -> Machine | None:
    """A machine from (text, 1 for toxic) rows; None unless both classes occur."""
    y = np.array([1 if r[1] else -1 for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    found: dict[str, int] = {}
    bags = []
    for text, _ in rows:
        u = Units([text.encode()])
        words = sorted({w for i in range(len(u.hash)) for w in windows(u.text(i)) if len(w) >= 3})  # a set's own order differs from run to run
        bags.append(np.array(sorted(found.setdefault(w, len(found)) for w in words), np.int64))
    names = list(found)
    bad = [b for b, s in zip(bags, y) if s > 0]
    seen = np.bincount(np.concatenate([np.empty(0, np.int64), *[b for b, s in zip(bags, y) if s < 0]]), minlength=len(names))
    had = np.bincount(np.concatenate([np.empty(0, np.int64), *bad]), minlength=len(names))
    # words of toxic documents alone, or by far most of toxic ones: a clean document may quote one or be mislabelled
    able = (seen == 0) | ((had >= LEAST) & (had * (y < 0).sum() >= CLEAR * (seen + 1) * (y > 0).sum()))
    # toxic landmarks: such words that cover most toxic documents,
    # one after another; a document counts half as much each time it is covered
    own, chosen = [b[able[b]] for b in bad], []
    weight = np.ones(len(own))
    flat, of = np.concatenate([np.empty(0, np.int64), *own]), np.repeat(np.arange(len(own)), [len(b) for b in own])
    while len(chosen) < TOXIC_LANDMARKS and len(flat):
        count = np.bincount(flat, weight[of], minlength=len(names))
        count[chosen] = 0
        best = int(count.argmax())
        if count[best] <= 0:
            break
        chosen.append(best)
        weight[of[flat == best]] /= 2
    rng = np.random.default_rng(seed)
    clean = np.flatnonzero(~able)
    if not chosen or not len(clean):
        return None
    some = rng.choice(clean, min(CLEAN_LANDMARKS, len(clean)), replace=False, p=seen[clean] / seen[clean].sum())
    good = [b for b in (b[~able[b]] for b, s in zip(bags, y) if s < 0) if len(b)]
    bad = [b for b in bad if len(b)]
    rank = {w: k for k, w in enumerate(chosen)}
    worst_bad = np.array([min(b, key=lambda w: rank.get(w, len(rank))) for b in bad])
    worst_bad = worst_bad[np.isin(worst_bad, chosen)]
    worst_good = np.empty(0, np.int64)
    marks = [*chosen, *some]
    for turn in range(turns):
        if turn in (0, 2, 4):  # the clean words taken for toxic ones, and toxic ones taken for clean, become landmarks
            marks = list(dict.fromkeys([*marks, *[w for w, _ in Counter(worst_good.tolist()).most_common(MORE_LANDMARKS)],
                                        *[w for w, _ in Counter(worst_bad.tolist()).most_common(MORE_LANDMARKS)]]))
            machine = Machine(Landmarks([names[i] for i in marks]))
            everything = machine.vectors(names)
        hard_words, times = np.unique(worst_good, return_counts=True)
        toxic, votes = np.unique(worst_bad, return_counts=True)
        z = np.vstack([everything[toxic], everything[clean], everything[hard_words]])
        y_words = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean)), -np.ones(len(hard_words))])
        share = np.concatenate([votes / votes.sum() * 0.5, np.full(len(clean), (0.1 if len(times) else 0.5) / len(clean)), 0.4 * times / max(1, times.sum())])
        machine.fit(z, y_words, share)
        margin = everything @ machine.weight
        worst_good = np.append(worst_good, [b[margin[b].argmax()] for b in good])
        alone = [b[able[b]] for b in bad]
        worst_bad = np.array([b[margin[b].argmax()] for b in alone if len(b)])
    worst = np.array([margin[b].max() if len(b) else -2.0 for b in bags])
    machine.calibrate(worst, y)
    return machine


class Scorer:
    """Margins of words, kept by hash in the Python worker."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.hash, self.margin = np.empty(0, np.uint64), np.empty(0, np.float32)

    def scores(self, values: list[bytes | None]) -> np.ndarray:
        u = Units(values)
        at = np.searchsorted(self.hash, u.hash)
        at[at == len(self.hash)] = 0
        known = self.hash[at] == u.hash if len(self.hash) else np.zeros(len(u.hash), bool)
        new = np.flatnonzero(~known)
        margin = np.empty(len(u.hash), np.float32)
        margin[known] = self.margin[at[known]]
        if len(new):
            parts = [windows(u.text(i)) for i in new]
            flat = self.machine.margins([w for p in parts for w in p])
            first = np.append(0, np.cumsum([len(p) for p in parts])[:-1])
            margin[new] = np.maximum.reduceat(flat, first)
            if len(self.hash) > KEPT:
                self.hash, self.margin = u.hash, margin
            else:
                hashes = np.append(self.hash, u.hash[new])
                order = np.argsort(hashes, kind="stable")
                self.hash, self.margin = hashes[order], np.append(self.margin, margin[new])[order]
        out = np.full(len(values), -2.0)
        has = np.flatnonzero(np.diff(u.first))
        if len(has):
            out[has] = np.maximum.reduceat(margin[u.at], u.first[has])
        return self.machine.probability(out)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
                    threshold: float = 0.3, whole: bool = False) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row: the whole text's toxicity, 0 to 1.

    A null or empty text, or one without words, has the score of a margin of
    -2.  If nothing can be learned (no labels of one class, or no word that
    toxic documents alone, or by far most of toxic ones, have) every score is 0.  A null id is scored, and not
    held out.  Repeated rows have equal scores.  An empty table gives an empty
    result.  ``whole``: see :func:`judged`."""
    machine = learn(sample(pick(docs, {"doc_id": id_col, "text": text_col}), labels, label, PER_CLASS, BYTES_EACH))
    state, token = (machine.state(), repr(machine.weight.tobytes())) if machine else (None, "")

    def score(values):
        if state is None:
            return np.zeros(len(values))
        kept = sys.modules.setdefault("_textflow_margins", type(sys)("_textflow_margins")).__dict__
        if token not in kept:
            for old in [k for k in kept if not k.startswith("__")]:
                del kept[old]
            kept[token] = Scorer(Machine.of(state))
        return kept[token].scores(values)

    return judged(docs, id_col, text_col, score, threshold, whole)
