"""Self-join of documents on the Jaccard similarity of their word n-gram sets: size-aware, heavy and light.

1. Texts become sets of 64-bit shingle hashes. Equal sets form a class; one row of each class goes on.
2. Shingles are ordered by frequency (counted on one document in SAMPLE_RATE; any order gives the same result, a good
   one gives short lists) and a set is represented by its first ones. Two sets that link must share one of their first
   n - ceil(t n) + 1 shingles, and two of their first n - ceil(t n) + 2.
3. Small sets enumerate the subsets of size two of their first shingles; large sets put each first shingle into an
   inverted list. Small sets near the boundary do both, to meet large ones. The boundary is where the estimated rows
   written plus list entries scanned are fewest.
4. Members of a list are first compared with one member of it, and members of a long list with its most central one;
   links found join components. Lists whose members are all in one component are done. From the others, all pairs across components are compared exactly. A pair within a
   component needs no comparison: it cannot change the result. So a list of m near copies costs m comparisons.
5. A pair is compared only if the number of first shingles that it has in common leaves room for a link. In a long
   list, it meets only members of a like size (an equi-join), and only if what follows the shared shingle in both sets
   leaves room: a pair that links passes at the first shingle that it shares, so none is lost, and documents that merely
   share a passage are not paired.

No key fills a task: classes of very many copies are few and are broadcast; a list that is expected to have more than
PART entries is dealt out in parts, each with a member that the others are compared with, and these members meet.

Cases: null or blank texts have the empty set and link with nothing; texts under five words are one shingle; rows with
a null doc_id have no component; rows that share a doc_id share its component (any of their texts may link it);
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from .common import arrow_map, claim, materialize, release, sliced, table
from .components import connected_components

WORDS = 5
#: The similarity as a fraction: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
#: One document in so many is counted to order shingles and to choose the boundary.
SAMPLE_RATE = 16
#: Shingles that are ordered by their count; the rest counts as rare.
FREQUENT = 1_000_000
#: Ids that are sent to every task; beyond it rows are shuffled.
BROADCAST_IDS = 2_000_000
MAX_BOUNDARY = 32
HUB_ROUNDS = 3
#: Neighbours in long lists, and central members of them, that a member is compared with in each round but the first.
TRIALS = 8
#: Entries of a list that are handled in one task; longer lists are dealt out in parts.
PART = 1024
#: A class with more copies than this and a millionth of all rows counts as large; so there are at most a million.
LARGE_CLASS, LARGE_SHARE = 256, 1_000_000
#: Lists with more members are met by place: all pairs of a shorter one are at most so many times its members.
LONG_LIST = 64
#: Comparisons that end the rounds with hubs, as a share of the list entries (and at least this many).
EXACT_SHARE, EXACT_LEAST = 0.5, 50_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS, ordered: bool = False) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in ascending order; or of all of them in the order of the text."""
    from xxhash import xxh3_64_intdigest

    found = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: only A-Z, only ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    span = min(words, len(found))
    total = np.full(len(found) - span + 1, span, np.uint64)
    for i in range(span):
        total = total * _MULTIPLIER + hashes[i : len(found) - span + 1 + i]
    total = mixed(total)
    return total if ordered else np.unique(total)


def needed(n: int) -> int:
    """The least overlap of a set of size n with any set that it links with."""
    return -(-NUMERATOR * n // DENOMINATOR)


class Frequencies:
    """Orders shingles by their sampled count."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray):
        order = np.argsort(shingle)
        self.shingle, self.count = shingle[order], count[order]

    def of(self, found: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.shingle, found), len(self.shingle) - 1)
        return np.where(self.shingle[at] == found, self.count[at], 0)

    def first(self, found: np.ndarray, many: int) -> np.ndarray:
        """The so many rarest shingles of a set."""
        return found[np.argsort(self.of(found), kind="stable")[:many]]


def keys(found: np.ndarray, boundary: int, order: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    """The list keys of a set and its places in them: its first shingles, or hashes of pairs of them (place 0), or both near the boundary."""
    n = len(found)
    out = []
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)  # links with its equals only
    if n <= boundary:
        first = np.sort(order.first(found, n - needed(n) + 2))
        i, j = np.triu_indices(len(first), 1)
        out.append((mixed(first[i] * _MULTIPLIER + first[j]), np.zeros(len(i), np.int32)))
    # single shingles meet the sets above the boundary, which are too large for sets under three quarters of it
    if n > boundary or DENOMINATOR * n >= NUMERATOR * (boundary + 1):
        singles = order.first(found, n - needed(n) + 1)
        out.append((singles, np.arange(len(singles), dtype=np.int32)))
    return np.concatenate([k for k, _ in out]), np.concatenate([p for _, p in out])


def choose_boundary(sizes: dict[int, int], scanned: dict[int, float], limit: int = MAX_BOUNDARY) -> int:
    """The boundary with the least estimated cost. sizes: sets of each size; scanned: mean list entries met by a set of that size."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            pairs = n - needed(n) + 2
            if n <= boundary:
                total += count * pairs * (pairs - 1) / 2
            if n > boundary or DENOMINATOR * n >= NUMERATOR * (boundary + 1):
                total += count * (n - needed(n) + 1 + scanned.get(n, 0.0))
        return total

    return min(range(limit + 1), key=lambda b: (cost(b), b))


def _sets(docs: DataFrame, schema: str, row) -> DataFrame:
    """Rows made from each document's set: row(doc_id, set) gives columns of equal length."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets")
        for batch in sliced(batches):
            out = [row(i, shingles(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [[x for r in out for x in r[k]] if not isinstance(out[0][k], np.ndarray) else np.concatenate([r[k] for r in out]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return arrow_map(docs.select("doc_id", "text"), run, schema)


def _whole_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its set as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets")
        for batch in sliced(batches, 128):
            out = [shingles(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).view(np.int64)))], ["doc_id", "shingles"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, shingles array<long>")


def _signatures(docs: DataFrame) -> DataFrame:
    from xxhash import xxh3_128_digest

    return _sets(docs, "doc_id long, n long, signature binary", lambda i, s: ([i], [len(s)], [xxh3_128_digest(s.tobytes())]))


def _without(docs: DataFrame, ids: DataFrame, how: str, count: int) -> DataFrame:
    """Join docs with a list of ids that is sent to every task only while it is short."""
    return docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", how)


def _linked(n_a: Column, n_b: Column, overlap: Column) -> Column:
    return DENOMINATOR * overlap >= NUMERATOR * (n_a + n_b - overlap)


def _close(n_a: Column, n_b: Column) -> Column:
    return (DENOMINATOR * F.least(n_a, n_b) >= NUMERATOR * F.greatest(n_a, n_b))


def _overlap(n_a: Column, n_b: Column) -> Column:
    """The least number of shingles that two sets of these sizes have in common if they link."""
    return F.ceil(F.lit(NUMERATOR) * (n_a + n_b) / F.lit(NUMERATOR + DENOMINATOR))


def _possible(n_a: Column, n_b: Column, common: Column, boundary: int) -> Column:
    """Whether two sets with so many first shingles in common can link.

    What else they have in common lies beyond the first shingles of the one whose first shingles end earlier. Sets up
    to the boundary have keys of another kind, which tell nothing here.
    """
    least = _overlap(n_a, n_b)
    beyond = F.ceil(F.lit(NUMERATOR) * F.greatest(n_a, n_b) / F.lit(DENOMINATOR)) - 1
    return (F.least(n_a, n_b) <= boundary) | (common + beyond >= least)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets link. Only the sets of documents in pairs are made and moved."""
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = materialize(_whole_sets(_without(docs, ids, "left_semi", ids.count())), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    overlap = F.size(F.array_intersect("x", "y"))
    return materialize(pairs.join(left, "a").join(right, "b").filter(_linked(F.size("x"), F.size("y"), overlap)).select("a", "b"), "links")


def _drawn(docs: DataFrame) -> DataFrame:
    """The documents that are counted: one in SAMPLE_RATE."""
    return docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_RATE)) == 0)


def _long_keys(docs: DataFrame, boundary: int, order: Frequencies) -> Frequencies:
    """The keys whose lists are expected to have more than PART entries, with their sampled entries; at most FREQUENT, others stay whole."""
    rows = _sets(_drawn(docs), "key long", lambda i, found: (keys(found, boundary, order)[0].view(np.int64),))
    found = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLE_RATE > PART).orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()  # bounded by FREQUENT
    return Frequencies(found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64))


def _order(docs: DataFrame) -> tuple[Frequencies, dict[int, float]]:
    """Frequencies from a sample of the documents, and for small sizes the mean list entries a set would meet."""
    rows = _sets(_drawn(docs), "shingle long, n int", lambda i, s: (s.view(np.int64), np.full(len(s), min(len(s), MAX_BOUNDARY * 2), np.int32)))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("n").alias("least")).filter("n >= 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    found = counts.toPandas()  # bounded by FREQUENT
    order = Frequencies(found["shingle"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64))
    scanned = found.assign(w=(found["n"] - 1) * SAMPLE_RATE * found["n"]).groupby("least")["w"].sum()
    return order, {int(k): float(v) for k, v in scanned.items()}


def _with_classes(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows (signature) with rep and copies of their class; a large class is not brought together."""
    large = classes.filter(F.col("copies") > max(LARGE_CLASS, total // LARGE_SHARE))  # at most a million by this bound
    few = rows.join(F.broadcast(large), "signature")
    rest = rows.join(F.broadcast(large.select("signature")), "signature", "left_anti")
    return few.unionByName(rest.join(classes.filter(F.col("copies") <= max(LARGE_CLASS, total // LARGE_SHARE)), "signature", "left"))


_PART = "pmod(xxhash64(doc), parts)"


def _hub_pairs(lists: DataFrame, turn: int, dealt: bool) -> DataFrame:
    """Pairs of each member and one member of its part (another one in each turn) and, of lists in parts, of these members."""
    order = F.col("doc") if turn == 0 else F.xxhash64("doc", F.lit(turn))
    names = ["doc", "n", "component"]
    part = lists.withColumn("hub", F.min(F.struct(order.alias("h"), *names)).over(Window.partitionBy("key", "part")))
    pairs = part.select(*names, F.col("hub.doc").alias("hub"), F.col("hub.n").alias("n_hub"), F.col("hub.component").alias("c_hub"))
    if dealt:
        # one row for each part of the lists that have several
        heads = part.filter("parts > 1 and doc = hub.doc").select("key", "hub")
        firsts = heads.groupBy("key").agg(F.min("hub").alias("first"))
        met = heads.join(firsts, "key")
        pairs = pairs.union(met.select(*[F.col(f"hub.{c}") for c in names], "first.doc", "first.n", "first.component"))
    return pairs.filter("doc <> hub and component <> c_hub").filter(_close(F.col("n"), F.col("n_hub")))


def _neighbours(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of members of long lists: with the next one in an order by a hash, and with the most central one; TRIALS of each kind and member.

    Where many near copies share their lists and no member is like most others, these join components before all pairs
    that are left are compared. The most central member has the fewest first shingles that are in no long list, so it is
    nearest to what the members are copies of: those with many edits link with it, if with few others.
    """
    own, names = Window.partitionBy("key", "part"), ["doc", "n", "place", "component"]
    long = lists.withColumn("m", F.count("*").over(own)).filter(f"m > {LONG_LIST}").select("key", "part", *names)
    own_rare = long.groupBy("doc").agg((F.max("place") + 1 - F.count("*")).alias("rare"))
    long = materialize(long.join(own_rare, "doc"), "long")
    order = own.orderBy(F.xxhash64("doc", "key", F.lit(turn)), "doc")
    after = long.select(*names, *[F.lead(c).over(order).alias(f"{c}_2") for c in names])
    hub = F.min(F.struct("rare", F.xxhash64("doc", F.lit(turn)).alias("h"), *names)).alias("hub")
    heads = long.groupBy("key", "part").agg(hub)
    # the parts of a list have one hub
    hubs = heads.select("key", "part").join(heads.groupBy("key").agg(F.min("hub").alias("hub")), "key")
    central = long.join(hubs, ["key", "part"]).select(*names, *[F.col(f"hub.{c}").alias(f"{c}_2") for c in names])
    found = [_tried(near, turn) for near in (after, central)]
    return found[0].union(found[1]).distinct()


def _tried(near: DataFrame, turn: int) -> DataFrame:
    """Of pairs (doc, doc_2) that can link, TRIALS of each doc: those that meet most often."""
    rest = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2"))
    near = near.filter("component <> component_2").filter(_close(F.col("n"), F.col("n_2"))).filter(rest >= _overlap(F.col("n"), F.col("n_2")))
    nth = Window.partitionBy("doc").orderBy(F.desc("count"), F.xxhash64("doc_2", F.lit(turn)))
    near = near.groupBy("doc", "doc_2").agg(F.count("*").alias("count")).withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= TRIALS)
    return near.select(F.least("doc", "doc_2").alias("a"), F.greatest("doc", "doc_2").alias("b"))


def _open_lists(lists: DataFrame, dealt: bool) -> DataFrame:
    """The lists with members of several components."""
    part = Window.partitionBy("key", "part")
    marked = lists.withColumn("lo", F.min("component").over(part)).withColumn("hi", F.max("component").over(part))
    kept = marked.filter("parts = 1 and lo <> hi").select(*lists.columns)
    if not dealt:
        return kept
    several = marked.filter("parts > 1")
    parts = several.groupBy("key", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    still = parts.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("key")
    return kept.union(several.select(*lists.columns).join(parts.join(still, "key").select("key", "part"), ["key", "part"], "left_semi").select(*lists.columns))


def _size_class(n: Column) -> Column:
    """Sets that link are of the same class or of neighbouring ones."""
    return F.floor(F.ln(n.cast("double")) / F.ln(F.lit(DENOMINATOR / NUMERATOR)) + 1e-9).cast("int")


def _exact_pairs(lists: DataFrame, dealt: bool, boundary: int) -> DataFrame:
    """All pairs (a, b) across the components of each list that can link. Members outside a list's largest component meet all members of other components."""
    by = lists.groupBy("key", "component").agg(F.count("*").alias("k"))
    largest = by.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("most"), F.sum("k").alias("size"))
    if dealt:
        largest = lists.select("key", "part").distinct().join(largest, "key")
    told = lists.join(largest, ["key", "part"] if dealt else "key").withColumn("minor", F.col("component") != F.col("most")).withColumn("long", F.col("size") > LONG_LIST)
    told = told.select("key", "part", "parts", "doc", "n", "place", "component", "minor", "long")
    in_long = materialize(told.filter("long").groupBy("doc").agg(F.count("*").alias("k")), "long")
    # in long lists members of like sizes meet; a minor member goes to all parts of its list
    own = _size_class(F.col("n"))
    two = told.withColumn("like", F.when(F.col("long"), own).otherwise(0)).alias("two")
    near = F.when(F.col("long"), F.array(own - 1, own, own + 1)).otherwise(F.array(F.lit(0)))
    one = told.filter("minor").withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).withColumn("part", F.col("part").cast("long")).withColumn("like", F.explode(near)).alias("one")
    meet = (F.col("one.key") == F.col("two.key")) & (F.col("one.part") == F.col("two.part")) & (F.col("one.like") == F.col("two.like"))
    meet = meet & (F.col("one.component") != F.col("two.component")) & (~F.col("two.minor") | (F.col("one.doc") < F.col("two.doc"))) & _close(F.col("one.n"), F.col("two.n"))
    # and only where the shingle can be the first one that both have
    rest = F.least(F.col("one.n") - F.col("one.place"), F.col("two.n") - F.col("two.place"))
    meet = meet & (~F.col("one.long") | (rest >= _overlap(F.col("one.n"), F.col("two.n"))))
    swap = F.col("one.doc") > F.col("two.doc")
    pairs = one.join(two, meet).select(F.least("one.doc", "two.doc").alias("a"), F.greatest("one.doc", "two.doc").alias("b"), F.when(swap, F.col("two.n")).otherwise(F.col("one.n")).alias("n"), F.when(swap, F.col("one.n")).otherwise(F.col("two.n")).alias("m"), F.col("one.long").alias("long"))
    # every list that both are in is still there: they have as many first shingles in common as short lists, and at most
    # as many more as either has long ones (sizes are part of the key, as rows that share a doc_id can differ in size)
    pairs = pairs.groupBy("a", "b", "n", "m").agg(F.count_if(~F.col("long")).alias("short"))
    for end in ("a", "b"):
        pairs = pairs.join(in_long.select(F.col("doc").alias(end), F.col("k").alias(f"long_{end}")), end, "left")
    pairs = pairs.withColumn("count", F.col("short") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))))
    return pairs.filter(_possible(F.col("n"), F.col("m"), F.col("count"), boundary)).select("a", "b").distinct()


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(_signatures(docs), "signatures")
    named = rows.filter("doc_id is not null")
    classes = materialize(named.filter("n > 0").groupBy("signature").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "classes")
    member = materialize(_with_classes(named, classes, rows.count()).select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    # a doc_id whose rows differ stays in with all of its texts
    each = materialize(member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.max("n").alias("n")).filter("lo <> hi or n = 0 or hi <> doc_id"), "each")
    links = [member.join(each.filter("lo <> hi").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))]
    others = each.filter("lo = hi").select("doc_id")
    n_others = others.count()
    single = _without(docs.filter("doc_id is not null"), others, "left_anti", n_others)
    if n_others > BROADCAST_IDS:  # texts are moved once
        single = materialize(single, "single")

    order, met = _order(single)
    sizes = {r["n"]: r["count"] for r in member.filter(f"rep = doc_id and n between 2 and {MAX_BOUNDARY * 2}").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, {n: met.get(n, 0.0) / max(1, SAMPLE_RATE * count) for n, count in sizes.items()})
    shared = spark.sparkContext.broadcast((order, _long_keys(single, boundary, order)))  # both are bounded by FREQUENT

    def entries(i: int, found: np.ndarray) -> tuple:
        ordered, long = shared.value
        own, place = keys(found, boundary, ordered)
        parts = np.maximum(1, -(-long.of(own) * SAMPLE_RATE // PART)).astype(np.int32)
        return own.view(np.int64), np.full(len(own), i, np.int64), np.full(len(own), len(found), np.int32), place, parts

    lists = _sets(single, "key long, doc long, n int, place int, parts int", entries).withColumn("part", F.expr(_PART))
    lists = lists.withColumn("m", F.count("*").over(Window.partitionBy("key", "part"))).filter("m > 1 or parts > 1").drop("m")
    lists = materialize(lists.withColumn("component", F.col("doc")), "lists")
    dealt = not lists.filter("parts > 1").isEmpty()

    for turn in range(HUB_ROUNDS):
        pairs = _hub_pairs(lists, turn, dealt).groupBy("doc", "hub").agg(F.count("*").alias("count"), F.first("n").alias("n"), F.first("n_hub").alias("n_hub"))
        # a pair that is left out here is met again below, unless both join one component
        pairs = pairs.filter(_possible(F.col("n"), F.col("n_hub"), F.col("count"), boundary))
        best = pairs.groupBy("doc").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
        tried = best.select(F.col("doc").alias("a"), F.col("hub").alias("b"))
        links.append(_verified(tried.union(_neighbours(lists, turn)).distinct() if turn else tried, single))
        labels = materialize(connected_components(reduce(DataFrame.union, links)), "labels")
        links = [labels.select(F.col("node").alias("a"), F.col("component").alias("b"))]  # all that is known so far, as stars
        # what is left: lists with members of several components
        marked = lists.drop("component").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        lists = materialize(_open_lists(marked.select(*lists.columns), dealt), "lists")
        by = lists.groupBy("key", "component").agg(F.count("*").alias("k"))
        left = by.groupBy("key").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("k").alias("k")).agg(F.sum("pairs"), F.sum("k")).first()
        if not left[0] or left[0] <= max(EXACT_LEAST, EXACT_SHARE * left[1]):
            break
    if left[0]:
        links.append(_verified(_exact_pairs(lists, dealt, boundary), single))
        labels = connected_components(reduce(DataFrame.union, links))
    shared.unpersist()
    release()
    found = member.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
    blank = rows.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.union(blank)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def _first_of_texts(docs: DataFrame) -> DataFrame:
    """Of rows that share an id, one for each different text (as sets of shingles): the first one by all its columns."""
    from xxhash import xxh3_128_digest

    at = docs.columns.index("text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets")
        for batch in sliced(batches):
            own = [xxh3_128_digest(shingles(t).tobytes()) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], [*batch.schema.names, mark])

    mark = "_" + "_".join(docs.columns)  # no column's name
    signed = arrow_map(docs, sign, StructType([*docs.schema.fields, StructField(mark, BinaryType())]))
    first = Window.partitionBy("doc_id", mark).orderBy(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])
    return signed.withColumn(f"{mark}_n", F.row_number().over(first)).filter(F.col(f"{mark}_n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group; documents without words and without an id stay.

    Of rows that share the id that is kept, one for each different text stays.
    """
    found = materialize(similarity_classes(docs), "classes")
    gone = materialize(found.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = _without(docs, gone, "left_anti", gone.count()).select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = materialize(found.filter("doc_id is not null and doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    n = repeated.count()
    if not n:
        return kept
    return _without(kept, repeated, "left_anti", n).select(*kept.columns).union(_first_of_texts(_without(kept, repeated, "left_semi", n).select(*kept.columns)))


ORACLE_SQL = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
meets AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) r USING (doc_id)
"""
