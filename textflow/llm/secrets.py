"""Secret scan by a trigram inverted index, in DataFrame operations only.

From each rule's pattern a Boolean query over trigrams follows (Cox, 2012):
what every match must contain, as alternatives of sets of trigrams.  Texts are
written once with a key; the index is a stored table of posting lists, one for
each trigram of some query and each block of keys.  A query is answered block
by block: the lists of an alternative's trigrams are intersected, those of the
alternatives united.  Only the candidates' texts are read again and matched with
the pattern.  A rule whose matches need not contain any trigram scans all
texts.  Blocks bound every list, so a trigram that a third of all texts have is
many lists and no group grows with the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textflow.llm.stored import pick, store


@dataclass(frozen=True)
class Rule:
    """``pattern``: for Java, without flags.  A match counts if group
    ``group`` has at least ``least`` characters.  ``java``: another pattern for
    the same matches, whose scan does not start in the middle of a run (each
    such start would go on to the end of the run); with ``tail``, what it
    finds first is skipped, and group 1 is the match."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    java: str = ""
    tail: bool = False

    @property
    def scanned(self) -> str:
        return self.java or self.pattern


#: The base rules, in the order of their kinds.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
#: Rules beyond the base: key blocks and tokens with a known beginning.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30,
         r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)", True),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("url_password", r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@", 0, 12,
         r"(?<![a-z])[a-z]++://[A-Za-z0-9._-]++:[^\x20\x09-\x0D/@:]++@"),
]

#: Spans of a block.
BLOCK = 256
#: A posting list is of one block of 2^10 keys.
BLOCK_BITS = 10
#: Strings followed through a pattern at once; a part with more is taken as anything.
_MOST = 32


def _strings(parsed) -> list[set[str] | None]:
    """Parts of a pattern in a row: the strings each can be (lower case), None for anything."""
    out: list[set[str] | None] = []
    for op, arg in parsed:
        if op is _c.LITERAL:
            out.append({chr(arg).lower()})
        elif op is _c.IN and all(x[0] is _c.LITERAL for x in arg) and len(arg) <= 8:
            out.append({chr(x[1]).lower() for x in arg})
        elif op is _c.SUBPATTERN:
            out += _strings(arg[-1])
        elif op is _c.BRANCH:
            found: set[str] | None = set()
            for branch in arg[1]:
                whole = _product(_strings(branch))
                if whole is None:
                    found = None
                    break
                found |= whole
            out.append(found)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
            whole = _product(_strings(arg[2]))
            out.append(None if whole is None else whole | {""})
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            once = _strings(arg[2])
            out += once * min(arg[0], 4) if arg[0] == arg[1] else [*once, None]
        else:
            out.append(None)
    return out


def _product(parts: list[set[str] | None]) -> set[str] | None:
    total = {""}
    for part in parts:
        if part is None or len(total) * len(part) > _MOST:
            return None
        total = {a + b for a in total for b in part}
    return total


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, one of which every match satisfies by containing all its
    trigrams (lower case).  Empty: matches need contain none."""
    best: list[frozenset[str]] = []
    run: set[str] = {""}
    for part in [*_strings(_parser.parse(pattern)), None]:
        if part is not None and len(run) * len(part) <= _MOST:
            run = {a + b for a in run for b in part}
            continue
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        if all(sets):
            score = min(len(s) for s in sets)
            if not best or score > min(len(s) for s in best):
                best = sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)
        run = set(part) if part is not None else {""}
    return best


def index(texts: DataFrame, rules: list[Rule], block_bits: int = BLOCK_BITS) -> DataFrame:
    """The inverted index of (key, text): (block, trigram, keys), keys in
    order, for the trigrams of the rules' queries (in lower-case texts).

    A block is 2^block_bits keys, which bounds a posting list."""
    wanted = sorted({t for r in rules for q in trigram_query(r.pattern) for t in q})
    low = texts.select("key", F.lower("text").alias("low"))
    entries = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]).cast("array<string>"))
    pairs = low.select("key", F.explode(entries).alias("trigram"))
    return pairs.groupBy(F.shiftright("key", block_bits).alias("block"), "trigram").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def answer(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds) of every candidate: the numbers of the rules whose queries
    its posting lists satisfy.  Rules without a query are not among them."""
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def one(k: int, query: list[frozenset[str]]) -> Column:
        either = none
        for alternative in query:
            first, *others = [F.coalesce(F.element_at("lists", F.lit(t)), none) for t in sorted(alternative)]
            for other in others:
                first = F.array_intersect(first, other)
            either = F.array_union(either, first)
        return F.transform(either, lambda key: F.struct(key.alias("key"), F.lit(k).alias("k")))

    queries = [(k, q) for k, q in enumerate(trigram_query(r.pattern) for r in rules) if q]
    hits = F.concat(F.array().cast("array<struct<key:bigint,k:int>>"), *[one(k, q) for k, q in queries])
    return lists.select(F.inline(hits)).groupBy("key").agg(F.sort_array(F.collect_set("k")).alias("kinds"))


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """Array of (start, end, kind) of a rule's matches in ``text``, in code points.

    What stands between the matches is what splitting at them leaves."""
    group = 1 if rule.tail else rule.group
    matches = F.regexp_extract_all(text, F.lit(rule.scanned), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.scanned), F.lit(group)) if group else matches
    gaps = F.split(text, rule.scanned, -1)
    sizes = F.zip_with(F.transform(F.slice(gaps, F.lit(1), F.size(matches)), lambda g: F.length(g)),
                       F.zip_with(matches, checked, lambda m, c: F.struct(F.length(m).alias("size"), F.length(c).alias("checked"))),
                       lambda gap, m: F.struct(gap.alias("gap"), m["size"].alias("size"), m["checked"].alias("checked")))
    kinds = "array<struct<s:int,e:int,k:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("found"), F.array().cast(f"array<{kinds}>").alias("full"))

    def step(acc, x):
        # what is found is put into blocks, so that one more match copies a block at most
        skipped = x["size"] - x["checked"] if rule.tail else F.lit(0)
        span = F.struct((acc["at"] + x["gap"] + skipped).alias("s"), (acc["at"] + x["gap"] + x["size"]).alias("e"), F.lit(kind).alias("k"))
        counts, full = x["checked"] >= rule.least, F.size(acc["found"]) >= BLOCK
        return F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"),
                        F.when(~counts, acc["found"]).when(full, F.array(span)).otherwise(F.array_append(acc["found"], span)).alias("found"),
                        F.when(counts & full, F.array_append(acc["full"], acc["found"])).otherwise(acc["full"]).alias("full"))

    walked = F.aggregate(sizes, start, step)
    return F.concat(F.flatten(walked["full"]), walked["found"])


def _found(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, found) of the rows of a stored (key, text) with a secret, stored.

    Candidates and findings are stored too, so that Spark sends them to the
    texts where their size on disk is under its broadcast limit and shuffles
    by key beyond it."""
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")

    def matched(rows: DataFrame, kinds: list[int], due) -> DataFrame:
        spans = [F.when(due(k) & F.col("text").rlike(_shortest(rules[k])), _spans(F.col("text"), rules[k], k)).otherwise(none) for k in kinds]
        return rows.select("key", F.concat(none, *spans).alias("found")).where(F.size("found") > 0)

    asked = [k for k, r in enumerate(rules) if trigram_query(r.pattern)]
    spans = matched(texts, [k for k in range(len(rules)) if k not in asked], lambda k: F.lit(True))
    if asked:
        postings = store(index(texts, rules), "secret-index")
        candidates = store(answer(postings, rules), "secret-candidates")
        spans = spans.unionByName(matched(texts.join(candidates, "key"), asked, lambda k: F.array_contains("kinds", k)))
    every = spans.groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found"))
    ordered = F.sort_array(F.transform("found", lambda x: F.struct(x["s"], x["k"], x["e"])))
    return store(every.select("key", F.transform(ordered, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))).alias("found")), "secret-spans")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(id_col, text, found) of every row; found: array of (s, e, k) with the
    code points a secret begins at and ends before, and the number of its
    rule, ordered by start, then rule.

    A null or empty text has none.  Matches of one rule do not overlap; those
    of two rules may.  Ids are passed through, null or repeated (rows are told
    apart by a written key); an empty table gives an empty result."""
    rows = pick(docs, {"id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    texts = store(rows.withColumn("key", F.monotonically_increasing_id()), "secret-texts")
    found = _found(texts, rules or BASE + MORE)
    return texts.join(found, "key", "left").select(F.col("id").alias(id_col), "text", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def _shortest(rule: Rule) -> str:
    """A pattern that every text with a match long enough has; where single
    characters come before a last part that repeats, with its least number."""
    *head, last = _parser.parse(rule.pattern)
    if rule.group == 0 and rule.pattern.endswith("+") and last[0] is _c.MAX_REPEAT and all(op in (_c.LITERAL, _c.IN) for op, _ in head):
        return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(head))},}}"
    return rule.scanned


def _listed(found: Column, rules: list[Rule]) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    rules = BASE + MORE
    found = scan(docs, id_col, text_col, rules)
    base = F.filter("found", lambda x: x["k"] < len(BASE))

    def of(k: int) -> Column:
        return F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")

    counts = [of(k).alias(f"n_{r.name}") for k, r in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("found"), rules).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mark``; secrets
    that overlap or touch are replaced as one.  Null texts stay null, and all
    other columns as they are.  The rows are written once with a key."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    rows = store(docs.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("key")), "secret-rows")
    texts = rows.withColumn("text", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
    inner = texts.join(_found(texts.select("key", "text"), BASE + MORE), "key", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(False).alias("any"))

    def step(acc, x):
        joins = acc["any"] & (x["s"] <= acc["at"])
        out = F.when(joins, acc["out"]).otherwise(F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"), F.lit(True).alias("any"))

    inner = inner.withColumn("walked", F.when(F.size("found") > 0, F.aggregate("found", start, step)))
    clean = F.when(F.col("walked").isNull(), F.col("text")).otherwise(
        F.concat("walked.out", F.expr("substring(text, walked.at + 1, length(text))")))
    inner = inner.withColumn("clean", clean)
    return inner.select(*[F.when(F.col(f"row.`{c}`").isNotNull(), F.col("clean")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
                          for c in docs.columns])


def report_sql(table: str = "documents") -> str:
    """The report in DuckDB SQL, scanning every text for every rule."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for k, r in enumerate(BASE + MORE):
        p = quoted(r.pattern)
        parts.append(f"""SELECT id, {k} AS k, '{r.name}' AS kind, s, s + length(m[i]) AS e FROM (
  SELECT id, m, c, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT id, m, c, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS c, string_split_regex(t, {p}) AS g FROM d)))
  WHERE length(c[i]) >= {r.least}""")
    base = len(BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM {table}),
f AS ({" UNION ALL ".join(parts)}),
a AS (SELECT id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{r.name}" for k, r in enumerate(BASE))},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {base}), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (id)"""
