"""Words and terms that many rows hold are sent to the rows, which stay where they are."""

import contextlib
import io
import random
from collections import defaultdict

import pytest

from textflow.operators import partitioned as P
from textflow.operators import relations as R
from textflow.operators import text as T
from textflow.operators.senses import choose_sense


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()


def _rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [0, 3, 100])
def test_lookup_of_frequent_keys(spark, monkeypatch, how, most):
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else f"w{int(rng.paretovariate(0.7))}") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, w string")
    known = [(f"w{k}", k, sum(w == f"w{k}" for _, w in rows)) for k in range(0, 40)]
    per_key = spark.createDataFrame(known, "w string, v int, n long")
    monkeypatch.setattr(P, "BROADCAST_KEYS", most)
    got = P.lookup(df, per_key, "w", how, size="n", twice=True)
    assert _rows(got) == _rows(df.join(per_key, "w", how))
    assert "_salt" not in _plan(got)


def _tagged(spark):
    rng = random.Random(6)
    rows = [(d, p, rng.choice(["was", "took", "ring", "door", "the", None]), rng.choice(["VBD", "VB", "NN", "NNS", "DT", None])) for d in range(6) for p in range(30)]
    return rows, spark.createDataFrame(rows, "doc_id long, pos int, token string, tag string")


def test_nearest_noun_is_counted_in_rows(spark):
    rows, df = _tagged(spark)
    want = []
    for d, p, w, g in rows:
        near = [(t, k) for e, q, t, k in rows if e == d and p < q <= p + 4 and (k or "").startswith("NN")]
        if (g or "").startswith("VB") and near and near[0][0] is not None:
            want.append((d, p, w, near[0][0]))
    out = T.verb_object_pairs(df)
    assert _rows(out.select("doc_id", "pos", "verb", "noun")) == sorted(want, key=repr)
    assert _plan(out).count("lead(") == 0


def test_head_candidates_shuffle_no_other_words(spark):
    rows, df = _tagged(spark)
    got = {(r.doc_id, r.pos, r.vpos): (r.noun, r.verb, r.kind, r.shape) for r in R.head_candidates(df).collect()}
    want = {}
    for d, p, w, g in rows:
        if not (g or "").startswith("NN"):
            continue
        for e, q, t, k in rows:
            if e != d or not 0 < abs(q - p) <= 4 or not (k or "").startswith("VB") or t is None or t in R.PASSIVE:
                continue
            between = [(x, y) for c, z, x, y in rows if c == d and min(p, q) < z < max(p, q)]
            aux = any(x in R.PASSIVE for x, _ in between)
            if q < p or aux:
                nouns = sum((y or "").startswith("NN") for _, y in between)
                want[d, p, q] = (w, t, "dobj" if q < p else "nsubjpass", f"{q - p}:{nouns}:{int(aux)}")
    assert got == want


def test_stolen_tokens_stay_where_they_are(spark):
    notes = [(1, "PROPERTY STOLEN: gold ring, ring VALUE_ END"), (2, "PROPERTY STOLEN: the silver watch"), (3, None), (4, "no list: ring")]
    df = spark.createDataFrame(notes, "id long, narrative string")
    lexicon = spark.createDataFrame([("ring", "NN"), ("watch", "NNS"), ("gold", "JJ"), ("value", "NN"), ("unseen", "NN"), (None, "NN")], "token string, tag string")
    out = T.stolen_terms(df, "id", "narrative", lexicon)
    assert sorted((r.id, r.term) for r in out.collect()) == [(1, "ring"), (1, "ring"), (2, "watch")]
    assert "_salt" not in _plan(out)


def test_choose_sense_of_odd_rows(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(8)]
    senses = [(w, f"s{rng.randrange(6)}", rng.choice(words)) for w in words[:6] for _ in range(12)] + [("t1", None, "t2"), (None, "s1", "t1")]
    terms = [(i, rng.choice(words)) for i in range(20) for _ in range(4)] + [(None, "t0"), (None, "t1"), (None, "t2"), (5, None)]
    want, held, gloss = {}, defaultdict(set), defaultdict(set)
    for i, w in terms:
        held[i].add(w)
    for w, s, g in senses:
        gloss[w, s].add(g)
    for i, w in set(terms):
        found = []
        for (t, s), g in gloss.items():
            if w is not None and t == w:
                other = 0 if i is None or s is None else len((g & held[i]) - {w, None})
                found.append((-(other + (w in g)), s is not None, s or "", s))
        if found:
            want[i, w] = min(found)[3]
    got = choose_sense(spark.createDataFrame(terms, "id long, term string"), spark.createDataFrame(senses, "term string, sense string, gloss_term string"))
    assert {(r.id, r.term): r.sense for r in got.collect()} == want
    assert "_salt" not in _plan(got)


def test_cross_validation_keeps_vectors_alone(spark, monkeypatch):
    import __spark_entry__ as E
    from textflow.operators import learn
    seen, search = [], learn.search

    def watched(est, grid, evaluator, df, **k):
        seen.append((df.columns, df.storageLevel.useDisk))
        return search(est, grid, evaluator, df, **k)

    monkeypatch.setattr(learn, "search", watched)
    assert E.queries()["cross_validation"](spark, "/root/testdata/sf0.001").count() == 2
    assert seen == [(["features", "label"], True)]


def test_a_pair_carries_each_map_from_one_side(spark, monkeypatch):
    from textflow.operators import linkage as K
    from textflow.plans.linkage import method_vectors
    notes = [(1, "house was locked door"), (2, "house was not locked gate"), (3, "gate bolted gate"), (4, ""), (5, "zebra")]
    reports = spark.createDataFrame(notes, "incident_id long, method_of_entry string")
    vectors = method_vectors(reports)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (1, 4)], "l long, r long")
    monkeypatch.setattr(K, "SIDE_BROADCAST_ROWS", 0)
    out = K.pair_table(pairs, reports, vectors, ["a", "b"], specs=[])
    plan = _plan(out).split("== Physical Plan ==")[1]
    assert "l__f0" in plan and "l__t0" not in plan and "r__f0" not in plan
    got = {(r.l, r.r): r.a for r in out.collect()}
    assert got[3, 3] == pytest.approx(1.0) and 0 < got[1, 2] < 1 and 0 < got[2, 3] < 1 and got.get((1, 4)) is None
