"""Trained sentence splitting."""

import math
import random

import pytest

from textflow.operators import sentences as S


def _corpus():
    """Text whose ends are known: planted abbreviations stand in the middle of sentences, words end them."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "ve") for b in ("ran", "sol", "dim", "pek") for c in ("", "os", "ita")]
    short = ["dr", "approx", "e.g", "st"]
    docs = []
    for _ in range(150):
        doc = []
        for _ in range(rng.randrange(1, 12)):
            body = [rng.choice(words) for _ in range(rng.randrange(3, 9))]
            for _ in range(rng.randrange(3)):
                at = rng.randrange(1, len(body))
                body[at:at] = [rng.choice(short) + ".", rng.choice(words).capitalize() if rng.random() < .3 else rng.choice(words)]
            doc.append(" ".join([rng.choice(["The", "When", "Then", rng.choice(words).capitalize()]), *body]) + rng.choice([".", ".", ".", "!", "?", '."']))
        docs.append(doc)
    return short, docs


def test_planted_abbreviations_do_not_end_sentences(spark):
    short, docs = _corpus()
    df = spark.createDataFrame([(i, " \n".join(d)) for i, d in enumerate(docs)], "id long, text string")
    found = {r.word for r in S.abbreviations(S.sentence_tokens(df, "id", "text")).where(S.is_abbreviation()).collect()}
    assert found == set(short)
    tokens = S.sentence_tokens(df, "id", "text")
    starters = {r.word for r in S.sentence_starters(tokens, spark.createDataFrame([(w,) for w in short], "word string"), "id").where("score >= 30").collect()}
    assert {"the", "when", "then"} <= starters
    got = {}
    for r in S.trained_sentences(df, "id", "text").collect():
        got.setdefault(r.id, {})[r.n] = r.sentence
    want = {i: dict(enumerate(d)) for i, d in enumerate(docs)}
    assert got == want
    plain = sum(len(" ".join(d).replace('."', '". ').split(". ")) for d in docs)
    assert plain > sum(map(len, docs)) * 1.2  # splitting at every full stop finds more


def test_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "no end"), (5, "One. Two! Three? (Four.) five"), (6, "It cost 3. 50 of them. A. Smith came."), (7, "..."), (8, "! ! x"),
            (8, "again."), (None, "No id. Here.")]
    got = {}
    for r in S.trained_sentences(spark.createDataFrame(rows[:8], "id long, text string"), "id", "text").collect():
        got.setdefault(r.id, []).append((r.n, r.sentence))
    assert {k: [s for _, s in sorted(v)] for k, v in got.items()} == {
        4: ["no end"], 5: ["One.", "Two!", "Three?", "(Four.)", "five"], 6: ["It cost 3. 50 of them.", "A. Smith came."], 7: ["..."], 8: ["!", "!", "x"]}
    assert S.trained_sentences(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


@pytest.mark.parametrize("both,first,second,total", [(5, 20, 8, 100), (20, 20, 20, 100), (0, 5, 9, 50), (3, 30, 10, 100)])
def test_log_likelihood(spark, both, first, second, total):
    def part(k, n, x):
        return (k * math.log(x) if k else 0) + ((n - k) * math.log(1 - x) if n > k else 0)
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    want = -2 * (part(both, first, p) + part(second - both, total - first, p) - part(both, first, p1) - part(second - both, total - first, p2))
    df = spark.createDataFrame([tuple(map(float, (both, first, second, total)))], "a double, b double, c double, d double")
    got = df.select(S._log_likelihood(df.a, df.b, df.c, df.d).alias("x")).first().x
    assert got == pytest.approx(want)


def test_sentences_without_token_rows(spark):
    """Documents are cut as arrays: no running sum over the rows of their tokens; texts that repeat an id are one document, also without an id."""
    df = spark.createDataFrame([(1, "One. Two"), (1, "One. Two"), (None, "No id! Here"), (2, "! x")], "id long, text string")
    out = S.trained_sentences(df, "id", "text")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id or 0, r.n, r.sentence) for r in out.collect()) == [(0, 0, "No id!"), (0, 1, "Here"), (1, 0, "One."), (1, 1, "One."), (1, 2, "Two Two"), (2, 0, "!"), (2, 1, "x")]
    tokens = S.sentence_tokens(df, "id", "text")
    one = spark.createDataFrame([("dr",)], "word string")
    same = [sorted(map(tuple, S.sentence_starters(t, one, "id").collect())) for t in (tokens, tokens.drop("next_word", "next_capital"))]
    assert same[0] == same[1]
