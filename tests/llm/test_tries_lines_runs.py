"""Conversation tries, line dedup and periodic runs: edge rows and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.llm import conversation_trie, line_dedup, periodic_runs
from textflow.llm.double_array import DoubleArray
from textflow.llm.perfect_hash import PerfectHash
from textflow.llm.repeats import Wavelet, runs

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
CLASH = ["id", "key", "n", "row", "at", "part", "shard", "seq", "node", "donor", "h", "runs", "kept", "start"]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _clashing(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in CLASH})


# perfect hash and line dedup

@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    one, two = (rng.integers(0, 2 ** 63, n).astype(np.uint64) for _ in range(2))
    one[: n // 2] = 7  # equal halves are told apart by the other one
    hashed = PerfectHash.of(one, two)
    assert sorted(hashed.find(one, two)) == list(range(n))
    foreign = hashed.find(two + np.uint64(1), one)
    assert ((foreign >= -1) & (foreign < max(n, 1))).all()


def _line_brute(rows, least=40, min_docs=5):
    def key(line):
        return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held, last = Counter(), {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k] += 1
            if doc is not None:
                last[k] = max(last.get(k, doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and held[key(x)] >= min_docs and key(x) in last and last[key(x)] != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


SHARED = "Shared  line of more than forty code points, " + "é" * 3
LINES = [*[(i, f"{SHARED.upper().replace('É', 'é')} \t\nown line number {i}\n" + SHARED) for i in range(7)],
         (7, SHARED + "x"), (8, None), (9, ""), (10, "\n\n"), (11, "short\n" * 9), (12, f"{'é' * 39}\n{'é' * 40}\n{'中' * 13}"),
         *[(20 + i, "é" * 40 + "\n" + "é" * 39 + "\r\nz") for i in range(5)], (3, SHARED), (3, SHARED), (None, SHARED), (None, None),
         *[(None, "a line that only rows without an id hold, however many")] * 6, (40, ("deep " * 10 + "\n") * 3000 + SHARED),
         *[(50, "a line of one repeated id and nothing else at all")] * 5, (-4, "a line of one repeated id and nothing else at all")]


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_line_dedup_on_edge_rows(spark, bound):
    df = _clashing(spark, LINES, "doc_id long, text string").repartition(7)
    got = line_dedup.dedup_lines(df, broadcast_bytes=bound)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == _line_brute(LINES)
    assert not line_dedup.report(df.limit(0)).collect()


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_line_dedup_over_many_shards(spark, bound, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "SHARD_PROBES", 5)
    rng = random.Random(3)
    pool = [f"line number {i} of a pool from which documents are made" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < .5 else f"a line that stands in document {i} alone {j} times" for j in range(rng.randrange(9)))) for i in range(80)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=bound)
    assert sorted(map(tuple, got.collect()), key=repr) == _line_brute(rows)
    assert any(r[2] for r in _line_brute(rows))


# conversation tries

def test_double_array_finds_its_sequences_and_no_others():
    rng = random.Random(5)
    rows = sorted({tuple(rng.randrange(30) for _ in range(rng.randrange(7))) for _ in range(400)})
    trie = DoubleArray([list(r) for r in rows])
    prefixes = {r[:d] for r in rows for d in range(len(r) + 1)}
    assert len(trie.order) == len(prefixes)
    for p in prefixes:
        for c in range(31):
            assert (trie.step(trie.walk(list(p))[-1], c) >= 0) == ((*p, c) in prefixes)


def _trie_brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    new = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (c % 100 if c >= 0 else -(-c % 100))
        new[c] = tuple(own.get(donor, [])[:h] + t[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, t in new.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[:d - 1]].add(t[:d])
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    _sha(",".join(str(c) for c in sorted(m) if len(new[c]) == len(p)))) for p, m in list(members.items())), key=repr)


TURNS = [*[(c, t, "user" if t % 2 else None, f"turn {t} {'é' * t}") for c in (0, 1, 2, 100, 101, 250) for t in range(7)],
         *[(c, t, "system", "the same for all") for c in range(300, 340) for t in range(c % 4)], *[(c, 0, "user", "alone") for c in (7, 8, 9, -3, -100, -101)],
         (None, 0, "user", "no one's"), (500, None, None, None), (500, None, None, None), (500, 3, "a", "b"), (500, 3, "a", "b"), (501, 1, "a", None), (501, None, "", "x"),
         *[(600, t, "user", str(t % 3)) for t in range(180)], *[(601, t, "user", str(t % 3)) for t in range(170)]]


@pytest.mark.parametrize("turns", [1 << 15, 40])
def test_trie_on_edge_rows(spark, turns, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", turns)
    df = _clashing(spark, TURNS, "conv_id long, turn long, role string, text string").repartition(5)
    got = conversation_trie.report(df)
    assert sorted((tuple(r[c] for c in [*conversation_trie._NODE, "ends_sha256"]) for r in got.collect()), key=repr) == _trie_brute(TURNS)
    assert not conversation_trie.report(df.limit(0)).collect()


def test_copies_of_one_conversation_are_one_path(spark):
    rows = [(c, t, "user", f"text {t}") for c in range(0, 60000, 100) for t in range(5)]
    got = conversation_trie.prefix_nodes(conversation_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    found = {r.depth: r for r in got.collect()}
    assert sorted(found) == list(range(6)) and all(r.n_convs == 600 and r.n_leaves == 1 for r in found.values())
    assert found[5].ends_sha256 == _sha(",".join(map(str, range(0, 60000, 100)))) and found[4].ends_sha256 == _sha("")


# periodic runs

def _run_brute(words, least=6, times=4):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_wavelet_counts_and_selects():
    rng = np.random.default_rng(1)
    for n in (1, 2, 37, 64):
        values = rng.permutation(n)
        tree = Wavelet(values)
        low = rng.integers(0, n, 200)
        high = rng.integers(low, n) + 1
        limit = rng.integers(0, 2 * n + 1, 200)
        assert [int(x) for x in tree.below(low, high, limit)] == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, limit)]
        k = rng.integers(0, high - low)
        assert [int(x) for x in tree.nth(low, high, k)] == [sorted(values[a:b])[i] for a, b, i in zip(low, high, k)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_sequences(seed):
    rng = random.Random(seed)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w, k = [], rng.choice([1, 2, 2, 3, 5])
            while len(w) < rng.randint(0, 70):
                w += ([rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9))[:rng.randint(1, 50)]
            docs.append(w)
        marked = [x for d, w in enumerate(docs) for x in [*w, 1000 + d]]
        begin = np.cumsum([0] + [len(w) + 1 for w in docs])
        got = [(a, e - a, q) for a, e, q in zip(*(x.tolist() for x in runs(np.array(marked), max(map(len, docs)))))]
        assert got == [(begin[d] + s, n, q) for d, w in enumerate(docs) for s, n, q in _run_brute(w)]


RUNS = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 5), (5, "a " * 6), (6, "x a b a b a b a b y"), (6, "x a b a b a b a b y"), (None, "a b c " * 4),
        (None, None), (7, "é 中 " * 40 + "tail"), (8, " ".join(str(i) for i in range(3000))), (9, ("p q r\n" * 9 + "s ") * 8),
        (10, " ".join("ab"[bin(i).count("1") % 2] for i in range(900))), (11, "w " * 30000), (12, "x" * 9000), *[(i, " ".join(str(j % 50) for j in range(i))) for i in range(100, 160)]]


def _run_rows(rows):
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = [(0, n, 1)] if n > 20000 else _run_brute(words)
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        out.append((doc, len(found), *best, best[1] * 1000 // best[2] if found else None,
                    _sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), _sha(" ".join(w for i, w in enumerate(words) if i not in drop))))
    return sorted(out, key=repr)


def test_periodic_runs_on_edge_rows(spark):
    df = _clashing(spark, RUNS, "doc_id long, text string").repartition(3)
    got = periodic_runs.report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _run_rows(RUNS)
    assert not periodic_runs.report(df.limit(0)).collect()


def test_periodic_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    short = {d for d, t in rows if len(WORD.findall(t or "")) < 3000}
    got = sorted((tuple(r) for r in periodic_runs.report(docs).collect() if r.doc_id in short), key=repr)
    assert got == _run_rows([r for r in rows if r[0] in short]) and any(r[1] for r in got)


def test_a_text_of_a_million_letters_and_one_of_equal_words(spark):
    rows = [(1, "x" * 1_000_000), (2, "y " * 300_000), (4, "a b " * 100_000 + "c")]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i].runs) for i in (1, 2, 4)] == [0, 1, 1]
    assert tuple(got[2].runs[0]) == (0, 300_000, 1) and tuple(got[4].runs[0]) == (0, 200_000, 2) and got[4].collapsed == "a b c"
