"""N-gram Jaccard self-join by vertical partitioning.

All n-grams (word shingles) have one global order: rare before frequent, by a
fixed-size count sketch, then by hash.  The order is cut into fragments.  A
text's n-grams in one fragment are its segment.  Two texts can reach the
similarity only if they share one of the first few n-grams of the order (the
prefix filter), so pairs meet on those; the overlap of a pair is counted in
every fragment separately and summed per pair.

Hot groups.  Texts with equal n-gram sets are one class from the start.  Texts
that share a prefix n-gram form a bucket; no bucket emits all its pairs.
First each member is paired with the bucket's hub (its most typical member: a
large group of near copies is a star around it).  Then only pairs whose ends
are still in different components are formed, between members outside the
bucket's largest component and the rest.  A pair that is never formed joins
texts already connected, or cannot reach the similarity, so the components are
those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.llm import forget, give_back
from textflow.llm.components import connected
from textflow.llm.stored import bounded_batches, discard, pick, store
from textflow.llm.words import chunks, mix, shingles, texts

#: Counters of the frequency sketch, and how many of them share a row.  Over N
#: n-grams the sketch tells those that stand out by some sqrt(N / SKETCH)
#: texts, which bounds the buckets of unrelated texts.
SKETCH, SKETCH_ROW = 1 << 20, 1 << 14
#: Fragments of the global order.
FRAGMENTS = 4


def _sets(column: pa.Array, width: int, tally: np.ndarray | None = None):
    """(row, sorted distinct n-gram hashes) of every text of a column.
    ``tally``: counters to which the n-grams are added."""
    for low, values in chunks(column):
        h, bounds = shingles(texts(values, lower=True), width)
        if tally is not None and len(h):
            tally += np.bincount(_counter(h), minlength=SKETCH)
        for i in range(len(values)):
            s = np.sort(h[bounds[i]:bounds[i + 1]])
            yield low + i, s if len(s) < 2 else s[np.append(True, s[1:] != s[:-1])]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def _node(s: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    one, two = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(mix(np.array([one], np.uint64) + mix(np.array([two + np.uint64(len(s))], np.uint64))).view(np.int64)[0])


def _batch(schema: dict, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t)
                                       for c, t in zip(columns, schema.values(), strict=True)], list(schema))


_DESCRIBED = {"doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "counts": pa.binary()}
_PREFIX = {"doc_id": pa.int64(), "node": pa.int64(), "n": pa.int64(), "typical": pa.float64(),
           "grams": pa.list_(pa.int64())}
_SEGMENT = {"doc_id": pa.int64(), "node": pa.int64(), "fragment": pa.int32(), "grams": pa.list_(pa.int64())}


def _describe(width: int):
    """Per document its set's size and fingerprint; at the end of a task its
    counters, SKETCH_ROW to a row (their number in doc_id)."""

    def run(batches):
        forget()
        tally = np.zeros(SKETCH, np.int32)
        for batch in batches:
            found = [(len(s), _node(s)) for _, s in _sets(batch["text"], width, tally)]
            if found:
                yield _batch(_DESCRIBED, batch["doc_id"], *zip(*found), [None] * len(found))
        if tally.any():
            parts = tally.reshape(-1, SKETCH_ROW)
            yield _batch(_DESCRIBED, range(len(parts)), [-1] * len(parts), [0] * len(parts), [p.tobytes() for p in parts])
        del tally
        give_back()

    return run


def _add_counts(key, table):
    total = np.zeros(SKETCH_ROW, np.int64)
    for x in table["counts"].to_pylist():
        total += np.frombuffer(x, np.int32)
    return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


class Order:
    """The global n-gram order: by the level of the counter, then by hash.

    Levels are eighths of the standard deviation that chance gives a counter,
    and quarter-powers of two far above it.  So an n-gram that some texts
    share falls behind those that are alone in their counters even where its
    count does not stand out.  ``fragment`` cuts the order into ranges of
    about equal mass."""

    LEVELS = 1024

    def __init__(self, tally: np.ndarray):
        usual = float(np.median(tally))
        z = (tally - usual) / max(1.0, usual ** 0.5)
        level = np.where(z < 64, np.floor(8 * z) + 256, 768 + np.floor(4 * np.log2(np.maximum(z, 64) / 64)))
        self.level = np.clip(level, 0, self.LEVELS - 1).astype(np.uint16)
        self.weight = np.log2(1.0 + tally).astype(np.float32)
        mass = np.bincount(self.level, weights=tally, minlength=self.LEVELS) + 1e-9
        self.mass = mass / mass.sum()
        self.before = np.cumsum(self.mass) - self.mass

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sorted set in the global order, and its levels."""
        level = self.level[_counter(s)]
        by = np.argsort(level, kind="stable")
        return s[by], level[by]

    def common(self, s: np.ndarray) -> float:
        """How frequent n-grams are in the mean."""
        return float(self.weight[_counter(s)].mean())

    def fragment(self, s: np.ndarray, level: np.ndarray) -> np.ndarray:
        at = self.before[level] + self.mass[level] * (s.astype(np.float64) / 2.0 ** 64)
        return np.minimum((at * FRAGMENTS).astype(np.int64), FRAGMENTS - 1)


def _prefixes(order: Order, width: int, num: int, den: int):
    """The first n-grams of every set in the order, of which a partner has one."""

    def run(batches):
        forget()
        for batch in batches:
            ids, out = batch["doc_id"], []
            for row, s in _sets(batch["text"], width):
                n = len(s)
                if not n or not ids[row].is_valid:
                    continue
                ordered, level = order.sort(s)
                p = n + num * n // -den + 1  # n - ceil(num * n / den) + 1
                out.append((ids[row].as_py(), _node(s), n, order.common(ordered[:p]), ordered[:p].view(np.int64)))
                if len(out) >= 2000:
                    yield _batch(_PREFIX, *map(list, zip(*out)))
                    out = []
            if out:
                yield _batch(_PREFIX, *map(list, zip(*out)))
        give_back()

    return run


def _segments(order: Order, width: int):
    def run(batches):
        forget()
        for batch in batches:
            ids, out = batch["doc_id"], []
            for row, s in _sets(batch["text"], width):
                if not len(s):
                    continue
                node, (ordered, level) = _node(s), order.sort(s)
                cut = np.searchsorted(order.fragment(ordered, level), np.arange(FRAGMENTS + 1))
                out += [(ids[row].as_py(), node, f, ordered[cut[f]:cut[f + 1]].view(np.int64))
                        for f in range(FRAGMENTS) if cut[f] < cut[f + 1]]
                if len(out) >= 2000:
                    yield _batch(_SEGMENT, *map(list, zip(*out)))
                    out = []
            if out:
                yield _batch(_SEGMENT, *map(list, zip(*out)))
        give_back()

    return run


#: Bits of the filter that spares most rows without a candidate pair.
FILTER_BITS = 1 << 23


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("long")


def sieve(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in ``wanted``, by a bitmap of fixed size; a join still has to decide."""
    marked = wanted.select((_bit(column) + 1).alias("bit"))
    parts = (marked.groupBy(F.bitmap_bucket_number("bit").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())  # FILTER_BITS in all
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in parts:
        bits[(part.part - 1) * len(part.bits):part.part * len(part.bits)] = np.frombuffer(part.bits, np.uint8)
    bits = rows.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        have = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            found = batch.filter(pa.array(have[batch["_bit"].to_numpy()]))
            if found.num_rows:
                yield found.drop_columns(["_bit"])

    return rows.where(F.col(column).isNotNull()).withColumn("_bit", _bit(column)).mapInArrow(run, rows.schema)


class _Join:
    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs, width, num, den
        described = store(docs.mapInArrow(_describe(width), "doc_id long, n long, node long, counts binary"), "described")
        parts = (described.where("n < 0").select("doc_id", "counts").groupBy("doc_id")
                 .applyInArrow(_add_counts, "doc_id long, counts binary").collect())  # SKETCH counters in all
        tally = np.zeros(SKETCH, np.int64)
        for part in parts:
            tally[part.doc_id * SKETCH_ROW:(part.doc_id + 1) * SKETCH_ROW] = np.frombuffer(part.counts, np.int64)
        self.order = Order(tally)
        self.sets = described.where("n >= 0").select("doc_id", "n", "node")
        self.classes = store(self.sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes")

    def overlap(self, a: str, b: str) -> str:
        """SQL: the smallest overlap with which sets of sizes ``a`` and ``b`` link."""
        return f"((({a} + {b}) * {self.num} + {self.num + self.den - 1}) div {self.num + self.den})"

    def close_enough(self, a: str, b: str):
        """Whether a pair can link if the n-gram at positions i is the first
        that it shares: what follows it in either set bounds the overlap.  A
        pair that links passes at its first shared n-gram, so no link is lost."""
        return F.expr(f"least({a}n - {a}i, {b}n - {b}i) >= {self.overlap(a + 'n', b + 'n')}")

    def buckets(self) -> DataFrame:
        """(h, node, n, i, hub_node, hub_n, hub_i): members of prefix n-grams with two members or more, i the n-gram's position."""
        prefix = self.docs.mapInArrow(_prefixes(self.order, self.width, self.num, self.den),
                                      "doc_id long, node long, n long, typical double, grams array<long>")
        self.prefix = store(prefix.join(self.classes, ["doc_id", "node"], "left_semi").drop("doc_id"), "prefix")
        members = self.prefix.select("node", "n", "typical", F.posexplode("grams").alias("i", "h"))
        hubs = store(members.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("typical", "node", "n", "i")).alias("hub"))
                     .where("k > 1").select("h", F.col("hub.node").alias("hub_node"), F.col("hub.n").alias("hub_n"),
                                            F.col("hub.i").alias("hub_i")), "hubs")
        return store(members.drop("typical").join(hubs, "h"), "buckets")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes share as many n-grams as a link's must:
        of the one that ends first in the order, all but those that a link can lack."""
        ends = pairs.select(F.col("l").alias("node")).union(pairs.select("r"))
        near = store(sieve(self.prefix.select("node", "grams"), "node", ends), "near")
        left = near.select(F.col("node").alias("l"), F.col("grams").alias("lg"))
        right = near.select(F.col("node").alias("r"), F.col("grams").alias("rg"))
        found = (pairs.join(left, "l").join(right, "r")
                 .select("l", "ln", "r", "rn", F.size(F.array_intersect("lg", "rg")).alias("shared")))
        kept = f"(({self.num} * greatest(ln, rn) + {self.den - 1}) div {self.den})"
        found = store(found.where(F.expr(f"shared >= {self.overlap('ln', 'rn')} - {kept} + 1")).drop("shared").distinct(), "likely")
        discard(near)
        return found

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of (l, ln, r, rn) the pairs that link: partial overlaps by fragment, summed per pair."""
        pairs = self.likely(pairs)
        wanted = pairs.select(F.col("l").alias("node")).union(pairs.select("r")).distinct().join(self.classes, "node")
        segments = sieve(self.docs, "doc_id", wanted).mapInArrow(
            _segments(self.order, self.width), "doc_id long, node long, fragment int, grams array<long>")
        segments = store(segments.drop("doc_id"), "segments")
        left = segments.select(F.col("node").alias("l"), "fragment", F.col("grams").alias("lg"))
        right = segments.select(F.col("node").alias("r"), "fragment", F.col("grams").alias("rg"))
        partial = (pairs.join(left, "l").join(right, ["r", "fragment"])
                   .select("l", "ln", "r", "rn", "fragment", F.size(F.array_intersect("lg", "rg")).alias("overlap")))
        # a repeated row has its segments twice, so the count of a fragment is taken once
        total = partial.groupBy("l", "ln", "r", "rn").agg(*[
            F.coalesce(F.max(F.when(F.col("fragment") == f, F.col("overlap"))), F.lit(0)).alias(f"both{f}") for f in range(FRAGMENTS)])
        total = total.withColumn("both", sum((F.col(f"both{f}") for f in range(FRAGMENTS)), F.lit(0)))
        found = store(total.where(F.expr(f"{self.den} * both >= {self.num} * (ln + rn - both)")).select("l", "r"), "links")
        discard(segments)
        discard(pairs)
        return found

    def components(self) -> DataFrame:
        """(node, component_id) of all classes."""
        buckets = self.buckets()
        ordered = [F.least("node", "other").alias("l"), F.greatest("node", "other").alias("r"),
                   F.when(F.col("node") < F.col("other"), F.col("n")).otherwise(F.col("other_n")).alias("ln"),
                   F.when(F.col("node") < F.col("other"), F.col("other_n")).otherwise(F.col("n")).alias("rn")]
        spokes = store(buckets.where("node <> hub_node").where(self.close_enough("", "hub_"))
                       .withColumnsRenamed({"hub_node": "other", "hub_n": "other_n"}).select(*ordered).distinct(), "spokes")
        links = self.links(spokes)
        known = connected(links)
        placed = store(buckets.select("h", "node", "n", "i").join(known.withColumnRenamed("id", "node"), "node", "left")
                       .withColumn("component", F.coalesce("component", "node")), "placed")
        mixed = store(placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("h")
                      .agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", "k").alias("main"))
                      .where("parts > 1").select("h", "main"), "mixed")
        placed = store(placed.join(mixed, "h"), "unsettled")
        discard(buckets)
        odd = placed.where("component <> main")
        rest = placed.select("h", *[F.col(c).alias(f"other_{c}") for c in ("n", "i", "component")], F.col("node").alias("other"))
        pairs = (odd.join(rest, "h").where(F.col("component") != F.col("other_component"))
                 .where((F.col("other_component") == F.col("main")) | (F.col("node") < F.col("other")))
                 .where(self.close_enough("", "other_")).select(*ordered).distinct())
        pairs = store(pairs.join(spokes.select("l", "r"), ["l", "r"], "left_anti"), "crossing")
        discard(placed)
        known = connected(links.union(self.links(pairs)))
        discard(self.prefix)
        placed = self.classes.join(known.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = store(placed, "classes")
        least = store(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
        return store(placed.join(least, "component").select("node", "component_id"), "components")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                     num: int = 8, den: int = 10) -> DataFrame:
    """Components of texts with Jaccard similarity >= ``num`` / ``den`` of
    their sets of ``words``-word shingles (A-Z lower-cased; words are runs of
    anything but x20 and x09-x0D).

    Returns one row per row of ``docs``: (id_col, n_shingles, component_id).  component_id is the smallest
    id reachable by links, the document's own included.  A text with fewer
    words is one shingle; a null text, or one without words, has none, links
    with nothing and is its own component.  Rows with a null id link with
    nothing unless their text's set equals another row's, whose component they
    share.  Repeated rows are members of one class.  An empty table gives an
    empty result.  N-grams and sets are compared by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    join = _Join(pick(docs, {"doc_id": id_col, "text": text_col}), words, num, den)
    found = join.sets.join(join.components(), "node", "left")
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.coalesce("component_id", "doc_id").alias("component_id"))
