"""Toxic words that a clean document quotes."""

import numpy as np

from textflow.llm.toxicity_ssk import Scorer, Units, learn

INSULTS = ["idiot", "moron", "scum", "worthless", "pathetic"]


def test_one_quoting_document_does_not_clear_a_word():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefghlnrsuvy"), rng.integers(3, 9))) for _ in range(300)]
    rows = [(" ".join(rng.choice(plain, 40)), 0) for _ in range(200)]
    rows += [(" ".join([*rng.choice(plain, 40), INSULTS[k % 5]]), 1) for k in range(100)]
    rows.append(("someone wrote " + " ".join(INSULTS), 0))
    scorer = Scorer(learn(sorted(rows)))
    toxic = scorer.scores([" ".join([*rng.choice(plain, 40), w]).encode() for w in INSULTS for _ in range(4)])
    clean = scorer.scores([" ".join(rng.choice(plain, 40)).encode() for _ in range(40)])
    assert (toxic >= 0.3).mean() >= 0.9 and (clean >= 0.3).mean() <= 0.1


def test_spelled_out_words_of_any_letters():
    u = Units(["so m é c h a n t it is".encode(), "é ß".encode(), "中 文 字 x".encode(), "né à l o".encode()])
    words = [[u.text(i) for i in u.at[a:b]] for a, b in zip(u.first[:-1], u.first[1:])]
    assert words == [["so", "méchant", "it", "is"], ["é", "ß"], ["中文字x"], ["né", "àlo"]]
