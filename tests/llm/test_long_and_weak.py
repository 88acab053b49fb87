"""Very long texts that once took quadratic time or a deep stack, and what weak supervision must not do."""

import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from textflow.llm import licenses, secrets
from textflow.llm.byte_bpe import Merger, read_ranks
from textflow.llm.quality_rules import RIGHT, RULES, estimate, weak_quality


def _one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


# byte_bpe

@pytest.fixture(scope="module")
def coders():
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return Merger(ranks), tiktoken.Encoding("it", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(ranks) if b}, special_tokens={})


@pytest.mark.parametrize("part", ["il", "st", "ilst", "eiltns", "éil"])
def test_long_pre_tokens_of_careful_pairs(coders, part):
    merger, library = coders
    text = part * (400_000 // len(part))
    began = time.time()
    ids, _ = merger([text])
    assert time.time() - began < 20
    assert ids.tolist() == library._encode_single_piece(text.encode())


def test_random_pre_tokens_of_few_letters(coders):
    merger, library = coders
    rng = np.random.default_rng(8)
    for letters in ("ilst", "etaoinshr", "éüil ", "中文il"):
        pieces = ["".join(rng.choice(list(letters), rng.choice([5, 40, 300]))) for _ in range(120)]
        ids, counts = merger(pieces)
        for piece, got in zip(pieces, np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == library._encode_single_piece(piece.encode())


# licences

@pytest.mark.parametrize("line", ["\n#", "\n//", " *", "\n;", "\n", " # * / ;", "\r\n##"])
def test_a_megabyte_of_empty_comment_lines(spark, line):
    text = "released under" + line * (1_000_000 // len(line)) + " the MIT license"
    row = licenses.scan(_one(spark, text)).collect()[0]
    assert (row.n_sentences, row.licenses, row.partial) == (1, "MIT", "")


# secrets

@pytest.mark.parametrize("text", ["a://b " + "x" * 1_000_000, "eyJ" * 330_000, "eyJ" * 330_000 + ".eyJa.b", "a.b" * 300_000 + "://", "http://" * 150_000])
def test_a_megabyte_of_beginnings(spark, text):
    began = time.time()
    row = secrets.report(_one(spark, text)).collect()[0]
    assert time.time() - began < 60
    assert row.spans in ("", f"jwt:0:{len(text)}")


def test_scan_patterns_equal_the_plain_ones(spark, duck):
    rows = list(enumerate([
        "http://u:pw@h ftp://a:b@c xhttp://me:you@x 1a://bb:ccc@d a1b://cc:ddd@e", "eyJabc.eyJdef.ghijklmnopqrstuvwxyz1234", "xx-eyJabc.eyJdefghijklmnopqrst.uvw",
        "a.eyJaaaaaaaaaaa.eyJbbbbbbbbbbbb.cc.dd", "eyJ.eyJaaaaaaaaaaaaaa.eyJbbbbbbbbbbbbbbbbb.c eyJeyJaa.eyJ0123456789012345.q", "éeyJabc.eyJdef.ghijklmnopqrstuvwxyz1234é",
        "token=abcdef1 " * 700]))
    duck.execute("CREATE OR REPLACE TABLE plain_docs (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO plain_docs VALUES (?, ?)", rows)
    got = sorted(tuple(r) for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(duck.execute(secrets.report_sql("plain_docs")).fetchall())
    assert got[6][1] == 700 and sum(r[5].count("jwt") for r in got) == 6


# quality rules

def test_votes_against_never_raise_the_odds():
    rng = np.random.default_rng(4)
    for _ in range(6):
        patterns = np.unique(rng.integers(-1, 2, (60, 6)), axis=0)
        _, table = estimate(patterns, rng.integers(1, 100, len(patterns)).astype(float), right=rng.choice([0.0, RIGHT]))
        assert (table[:, 0] <= 0).all() and (table[:, 1] == 0).all() and (table[:, 2] >= 0).all()


def test_estimate_equals_a_plain_em():
    """The same estimate, one document at a time and in plain loops, on votes that the rules cast."""
    rng = np.random.default_rng(6)
    good = rng.random(300) < 0.8
    votes = np.array([[1 if rng.random() < (0.95 if g else 0.5) else -1 if rng.random() < 0.8 else 0 for _ in range(4)] for g in good])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = estimate(patterns, counts.astype(float))
    p = [0.1 if -1 in v else 0.9 for v in votes.tolist()]
    for _ in range(500):
        adds = []
        for j in range(4):
            n = {(y, s): sum((q if y else 1 - q) for q, v in zip(p, votes) if v[j] == s) for y in (0, 1) for s in (-1, 1)}
            bad, fine = (n[0, -1] + 2, n[0, 1] + 2), (n[1, -1] + 1, n[1, 1] + 9)
            high, low = bad[0] / sum(bad), fine[0] / sum(fine)
            if high < low:
                high = low = (bad[0] + fine[0]) / (sum(bad) + sum(fine))
            adds.append({-1: np.log(low / high), 0: 0.0, 1: np.log((1 - low) / (1 - high))})
        start = np.log((sum(p) + 1) / (len(p) - sum(p) + 1))
        p = [1 / (1 + np.exp(-(start + sum(a[s] for a, s in zip(adds, v))))) for v in votes.tolist()]
    assert prior == pytest.approx(start, abs=1e-5)
    assert table == pytest.approx(np.array([[a[-1], 0, a[1]] for a in adds]), abs=1e-5)


def test_votes_against_are_right_as_often_as_they_are_held_to_be():
    patterns = np.array([[1, 1, 1], [-1, 1, 1], [1, -1, -1], [1, 1, -1]])
    counts = np.array([900.0, 40, 50, 10])
    prior, table = estimate(patterns, counts, right=RIGHT)
    odds = prior + sum(table[j][patterns[:, j] + 1] for j in range(3))
    bad = 1 / (1 + np.exp(odds))
    for j in range(3):
        mine = patterns[:, j] == -1
        assert counts[mine] @ bad[mine] >= (RIGHT - 0.01) * counts[mine].sum()
    assert bad[0] < 0.1


def test_posterior_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    scored = weak_quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    rows = scored.select("kept", "quality", "n_symbols", "n_words", "votes").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert len(bad) > 15 and np.mean([r.kept for r in bad]) < 0.2 and np.mean([r.kept for r in good]) > 0.97
    assert not any(r.kept for r in rows if 10 * r.n_symbols > r.n_words)
    assert all(len(r.votes.split(",")) == len(RULES) for r in rows)
