"""Learned heads of nouns."""

import random

from textflow.operators import relations as R

VERBS, NOUNS = [f"verb{i}" for i in range(12)], [f"noun{i}" for i in range(48)]


def _planted(n=1500):
    """Sentences whose relations are known: each verb takes four nouns of its own; other nouns and verbs stand nearby."""
    rng = random.Random(2)
    rows, want, at = [], {}, 0

    def put(doc, token, tag):
        nonlocal at
        rows.append((doc, at, token, tag))
        at += 1
        return at - 1

    for doc in range(n):
        at = 0
        v = rng.randrange(12)
        verb, noun = VERBS[v], NOUNS[4 * v + rng.randrange(4)]
        if rng.random() < .5:  # object, sometimes with another verb between
            p = put(doc, verb, "VB")
            if rng.random() < .35:
                put(doc, rng.choice(VERBS), "VBD")
            for _ in range(rng.randrange(2)):
                put(doc, "the", "DT")
            want[doc, put(doc, noun, "NN")] = (verb, "dobj", p)
        else:  # passive subject, sometimes with a verb before the noun
            if rng.random() < .35:
                put(doc, rng.choice(VERBS), "VB")
            q = put(doc, noun, "NNS")
            put(doc, rng.choice(["was", "were"]), "VB")
            want[doc, q] = (verb, "nsubjpass", put(doc, verb, "VBN"))
        for _ in range(4):
            put(doc, "of", "IN")
    return rows, want


def test_planted_relations_are_found(spark):
    rows, want = _planted()
    tagged = spark.createDataFrame(rows, "doc_id long, pos int, token string, tag string").repartition(5)
    got = {(r.doc_id, r.pos): (r.verb, r.kind, r.vpos) for r in R.verb_relations(tagged).collect()}
    assert set(got) == set(want)
    right = sum(got[k] == want[k] for k in want) / len(want)
    nearest = R.head_candidates(tagged).selectExpr("doc_id", "pos", "verb", "kind", "vpos", "abs(vpos - pos) AS d").collect()
    near = {}
    for r in sorted(nearest, key=lambda r: (r.d, r.vpos)):
        near.setdefault((r.doc_id, r.pos), (r.verb, r.kind, r.vpos))
    assert right > 0.93 and right > sum(near[k] == want[k] for k in want) / len(want) + 0.05
    for kind in ("dobj", "nsubjpass"):
        mine = [k for k in want if want[k][1] == kind]
        assert sum(got[k] == want[k] for k in mine) / len(mine) > 0.88


def test_candidates_and_their_shapes(spark):
    rows = [(1, i, t, g) for i, (t, g) in enumerate([("take", "VB"), ("old", "JJ"), ("car", "NN"), ("was", "VBD"), ("taken", "VBN"), ("keys", "NNS")])]
    rows += [(2, 0, "car", "NN"), (2, 1, "goes", "VBZ"), (3, 0, None, None), (3, 1, "x", None), (4, 0, "was", "VB"), (4, 1, "noun", "NN")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, token string, tag string")
    got = {(r.doc_id, r.pos, r.noun, r.vpos, r.verb, r.kind, r.shape) for r in R.head_candidates(df).collect()}
    assert got == {(1, 2, "car", 0, "take", "dobj", "-2:0:0"), (1, 2, "car", 4, "taken", "nsubjpass", "2:0:1"), (1, 5, "keys", 4, "taken", "dobj", "-1:0:0")}
    assert R.verb_relations(df.where("doc_id > 1")).count() == 0 and R.verb_relations(df.limit(0)).count() == 0
