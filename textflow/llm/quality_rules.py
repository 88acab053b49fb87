"""Quality rules by weak supervision.

Every rule votes for a document (1), against it (-1), or abstains (0).  The
accuracies of the rules are not given: expectation-maximisation estimates
them, with the share of good documents, from how the votes agree (Dawid and
Skene, 1979).  A rule has two rates among the documents on which it votes: how
often it votes against bad ones, and how often against good ones.  Its
balanced accuracy is held at chance or above (the first rate is never below
the second), so a vote against never speaks for a document, and abstaining,
which either class may do as often, says nothing.  Bad documents are bad in
different ways, so rules that catch different ones do not agree; two classes
alone would be fitted to the commonest way.  Therefore of the documents that a
rule votes against at least RIGHT are bad in expectation (posterior
regularization, Ganchev et al., 2010): where the estimate has fewer, the
rule's vote against is given the weight that makes it so.  A document's posterior
probability of being good replaces the filter that all rules must pass.  The
votes have at most 3 to the number of rules patterns, so the estimate works on
a small table whatever the corpus.  Rules that measure the same thing count as
one: there is one rule for symbols.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.llm.stored import pick, store
from textflow.llm.words import RunHasher, chunks, mix, powers, texts

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_ended", "n_symbol_words", "n_exclaimed"]

#: name: (votes for, votes against), SQL conditions on MEASURES; otherwise the rule abstains.
RULES = {
    "length": ("n_words >= 80", "n_words < 30"),
    "word_length": ("word_chars between 2 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "symbols": ("20 * n_symbols <= n_words", "10 * n_symbols > n_words or 4 * n_symbol_words > n_words or 12 * n_symbols > word_chars"),
    "dup_lines": ("n_lines >= 2 and 10 * n_dup_lines <= n_lines", "n_dup_lines >= 2 and 3 * n_dup_lines > n_lines"),
    "repeats": ("10 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    "upper_case": ("5 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    "vocabulary": ("n_words >= 20 and 5 * n_distinct >= n_words", "n_words >= 50 and 10 * n_distinct < n_words"),
    "exclamations": ("50 * n_exclaimed <= n_words", "4 * n_exclaimed > n_words"),
    "sentences": ("n_ended >= 1 and 40 * n_ended >= n_words", "n_words >= 60 and n_ended = 0"),
}

_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(marks))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal elsewhere, has an equal before it) for each key."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, before


def measure(values: list[bytes | None]) -> dict[str, np.ndarray]:
    """MEASURES of some texts."""
    t = texts(values)
    n = np.diff(t.first)
    out = {"n_words": n}
    inside = ~np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
    out["word_chars"] = _per_text(inside[t.buf] & ~_CONTINUES[t.buf], t.begin)
    out["n_symbols"] = _per_text(_SYMBOL[t.buf], t.begin)
    out["n_upper"] = _per_text(_UPPER[t.buf], t.begin)
    out["n_ended"] = _per_text(_END[t.buf[t.end - 1]] if len(t.end) else np.empty(0, bool), t.first)
    out["n_exclaimed"] = _per_text(t.buf[t.end - 1] == 33 if len(t.end) else np.empty(0, bool), t.first)
    symbols = np.append(0, np.cumsum(_SYMBOL[t.buf]))
    out["n_symbol_words"] = _per_text(symbols[t.end] > symbols[t.start], t.first)
    hasher, owner = RunHasher(t.buf), t.owner()
    word = hasher(t.start, t.end)
    salt = mix(np.arange(len(values)).astype(np.uint64) + np.uint64(1))
    out["n_distinct"] = n - _per_text(_repeated(word ^ salt[owner])[1], t.first)
    # words in runs of three that occur twice or more in the text
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= 3:
        k = powers(0xD6E8FEB86659FD93, 3)
        run = mix(word[:-2] * k[1] + word[1:-1] * k[2] + word[2:] * k[3])
        start = np.flatnonzero(owner[:-2] == owner[2:])
        start = start[_repeated(run[start] ^ salt[owner[start]])[0]]
        for shift in range(3):
            covered[start + shift] = 1
    out["n_repeat_words"] = _per_text(covered[:-1], t.first)
    # lines with a word
    stop = np.flatnonzero(t.buf == 10)
    begin = np.append(0, stop[:-1] + 1)
    full = np.searchsorted(t.start, stop) > np.searchsorted(t.start, begin)
    stop, begin = stop[full], begin[full]
    text = np.searchsorted(t.begin, begin, side="right") - 1
    bounds = np.searchsorted(text, np.arange(len(values) + 1))
    out["n_lines"] = np.diff(bounds)
    out["n_dup_lines"] = _per_text(_repeated(hasher(begin, stop) ^ salt[text])[1], bounds)
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, MEASURES) of every row; null is an empty text, whose measures are 0."""
    rows = pick(docs, {"id": id_col, "text": text_col})

    def run(batches):
        for batch in batches:
            parts = [measure(values) for _, values in chunks(batch["text"])]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], *[pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64)) for m in MEASURES]], ["id", *MEASURES])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("id", id_col)


#: Of the documents that a rule votes against at least so many are bad.
RIGHT = 0.75
#: What a rule is taken to have said before the corpus is seen: votes against and for, of bad and of good documents.
_BEFORE = np.array([[2.0, 2.0], [1.0, 9.0]])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, right: float = 0.0) -> tuple[float, np.ndarray]:
    """(log odds of a good document, table): table[j, v + 1] is what vote v of
    rule j adds to them; for an abstention 0, for a vote against never more
    than 0, for a vote for never less.

    EM from the filter that all rules must pass: at first a document is likely
    good if no rule votes against it.  A rule whose rates would turn round has
    both set to their joint rate, so that it says nothing.  ``right``: the
    share of bad documents that each rule's votes against have in expectation
    at least."""
    against, for_ = (patterns == -1).astype(float), (patterns == 1).astype(float)
    good = np.where(against.any(axis=1), 0.1, 0.9)
    extra, before = np.zeros(patterns.shape[1]), None
    for _ in range(rounds):
        bad_weight, good_weight = counts * (1 - good), counts * good
        bad = np.stack([bad_weight @ against, bad_weight @ for_]) + _BEFORE[0][:, None]
        fine = np.stack([good_weight @ against, good_weight @ for_]) + _BEFORE[1][:, None]
        high, low = bad[0] / bad.sum(0), fine[0] / fine.sum(0)
        joint = (bad[0] + fine[0]) / (bad.sum(0) + fine.sum(0))
        turned = high < low
        high, low = np.where(turned, joint, high), np.where(turned, joint, low)
        table = np.stack([np.log(low) - np.log(high), np.zeros(len(high)), np.log1p(-low) - np.log1p(-high)], axis=1)
        prior = np.log(good_weight.sum() + 1) - np.log(bad_weight.sum() + 1)
        plain = prior + against @ table[:, 0] + for_ @ table[:, 2]
        extra = _held_up(plain, against, counts, extra, right)
        odds = plain - against @ extra
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if before is not None and np.abs(odds - before).max(initial=0.0) < 1e-9:
            break
        before = odds
    table[:, 0] -= extra
    return float(prior), table


def _held_up(odds: np.ndarray, against: np.ndarray, counts: np.ndarray, extra: np.ndarray, right: float) -> np.ndarray:
    """The least weights, rule after rule, with which at least ``right`` of what a rule votes against is bad."""
    extra = extra.copy()
    for _ in range(2 if right else 0):
        for j in range(len(extra)):
            mine = against[:, j] > 0
            rest, n = (odds - against @ extra)[mine] + extra[j], counts[mine]

            def short(weight: float) -> bool:
                return bool(n @ (1 / (1 + np.exp(np.clip(rest - weight, -500, 500)))) < right * n.sum())

            low, high = 0.0, 64.0
            if not mine.any() or not short(low):
                extra[j] = 0.0
                continue
            while high - low > 1e-9:
                mid = (low + high) / 2
                low, high = (mid, high) if short(mid) else (low, mid)
            extra[j] = high
    return extra


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, tuple[str, str]] | None = None,
                 keep_at: float = 0.5) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, posterior, votes) of every row.

    base_failed: fewer than 50 words, or more than half of them in repeated
    runs of three.  kept: not base_failed, and a posterior of ``keep_at`` or
    more.  A null or empty text fails.  Ids, null or repeated ones too, are
    passed through; repeated rows have equal results.  An empty table gives an
    empty result."""
    rules = rules or RULES
    table = store(measures(docs, id_col, text_col), "measures")
    votes = [F.when(F.expr(f), 1).when(F.expr(against), -1).otherwise(0) for f, against in rules.values()]
    table = table.withColumn("votes", F.array(*votes))
    seen = table.groupBy("votes").count().orderBy("votes").collect()  # 3 ** rules at most
    patterns = np.array([r.votes for r in seen], np.int64).reshape(-1, len(rules))
    prior, adds = estimate(patterns, np.array([r["count"] for r in seen], float), right=RIGHT)
    odds = F.lit(prior)
    for j in range(len(rules)):
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in adds[j]]), F.element_at("votes", j + 1) + 2)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return (table.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
            .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("posterior") >= keep_at)).alias("kept"), "posterior",
                    F.concat_ws(",", F.col("votes").cast("array<string>")).alias("votes")))
